"""Readers and writers for responses, features, question keys and submissions."""
