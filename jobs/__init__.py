"""Jobs over the library's operators, each with a command line, a small configuration and a function that takes a session."""
