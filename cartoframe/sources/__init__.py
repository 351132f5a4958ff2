"""Readers and writers of feature layers."""
