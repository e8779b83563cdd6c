"""Reading and writing the tables and files the jobs exchange."""
