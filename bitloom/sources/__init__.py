"""Where tensors come from and where factors go."""
