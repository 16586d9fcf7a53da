"""Pure functions over hooks, shapes and tensor values."""
