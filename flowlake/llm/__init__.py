"""Training-data operators (numbered 1-10). Nothing outside this subpackage imports it."""
