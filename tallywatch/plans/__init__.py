"""Registered queries, the frames they read, and their SQL counterparts."""
