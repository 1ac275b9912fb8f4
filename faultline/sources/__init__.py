"""Reading and writing test items, requests and project objects."""
