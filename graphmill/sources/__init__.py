"""Readers and writers: profiles, news, question sets, graph tables."""
