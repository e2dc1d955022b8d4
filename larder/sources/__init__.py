"""Reading and writing of libraries and captures."""
