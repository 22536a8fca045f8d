"""Terms as columns, and functions by URI."""
