"""Where orders come from and where results go."""
