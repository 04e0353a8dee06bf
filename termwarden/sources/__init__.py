"""Where release tables come from and where they are kept."""
