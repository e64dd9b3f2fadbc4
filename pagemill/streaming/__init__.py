"""The same operators over arriving pages and requests."""
