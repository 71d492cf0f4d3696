"""DataFrame-to-DataFrame operators over span-annotated records."""
