"""Training-data operators over whole corpora of text.

Nothing else in the library imports this subpackage.
"""
