"""JavaScript and TypeScript syntax: scanner, parser, shapes. Pure Python, run inside Arrow batches."""
