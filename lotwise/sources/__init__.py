"""Reading landed files and feeds; writing results."""
