"""Points tables from frames and files, results to files."""
