"""Operators for preparing training data: mixing, similarity search and joins,
licence, personal-data and toxicity handling, language identification and web
archives.  Nothing else in the library imports this subpackage."""
