"""Column functions: keys, names, ids, quantities. All but the marked ones are built-in expressions."""
