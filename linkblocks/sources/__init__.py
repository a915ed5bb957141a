"""Reading and writing of datasets, blocks and vectors."""
