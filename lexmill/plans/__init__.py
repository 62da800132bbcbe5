"""Plans that chain the operators."""
