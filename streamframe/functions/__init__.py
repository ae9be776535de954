"""Column functions: codecs, defaults on failed parses, row hashes, union types."""
