"""Log sources: JSON, JSONL and CSV text turned into raw records, then into events and rejections."""
