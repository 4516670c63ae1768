"""Where data comes from and goes to: folders, configuration, the table store."""
