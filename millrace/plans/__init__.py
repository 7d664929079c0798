"""The serializable plan, its static check and its compiler."""
