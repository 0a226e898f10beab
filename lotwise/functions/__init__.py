"""Column-to-Column functions: text, numbers, dates, flags, files and addresses."""
