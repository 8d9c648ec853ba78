"""Reading and writing of contacts, change logs, graphs and stored models."""
