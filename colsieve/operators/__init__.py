"""Column subset selection: kernels for one matrix, distributed forms, and their registry."""
