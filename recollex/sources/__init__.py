"""Readers and writers of documents, snapshots, projects and media."""
