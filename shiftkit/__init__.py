"""DataFrame operators that ask how prepared and synthesised features hold up when tabular data shift."""
