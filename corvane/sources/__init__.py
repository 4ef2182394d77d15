"""Readers and writers of the corpus, judgment and run formats."""
