"""Sources and sinks: JSONL, transcripts, feeds, captures, listings, corpus shards."""
