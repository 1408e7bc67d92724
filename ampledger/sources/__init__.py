"""Readers and writers of meters, transformers, labels, predictions and runs."""
