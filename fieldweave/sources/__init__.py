"""Reading repository documents and writing reports."""
