"""Column functions: text keys, dates, lexicon matching."""
