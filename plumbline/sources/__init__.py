"""Reading and writing tables, and the runner of estimation specs."""
