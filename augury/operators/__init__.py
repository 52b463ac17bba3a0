"""Operators composed from DataFrame plans, with Arrow-batched Python only where no built-in can express them."""
