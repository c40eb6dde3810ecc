"""Source text to functions, types, macros, calls and changes: table functions over pandas frames."""
