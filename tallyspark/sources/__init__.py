"""Where relations come from and go to."""
