"""Sources: directories of files, and the relations inside image files."""
