"""Derived views and independent SQL used to check the library's results."""
