"""Readers and writers for the file layouts that labelled data come in."""
