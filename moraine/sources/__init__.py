"""Reading and writing of stored tables, shards and files."""
