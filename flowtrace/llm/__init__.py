"""Operators that prepare a text corpus for language-model training; nothing else in flowtrace imports them."""
