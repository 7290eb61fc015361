"""Readers and writers of the JSON documents and tables the engine works on."""
