"""Where change logs come from and go to."""
