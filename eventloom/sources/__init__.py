"""Reading event tables and texts, cleaning and splitting them, and writing results."""
