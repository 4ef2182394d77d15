"""Column functions and the few Arrow UDFs behind them."""
