"""Rows one by one: a finite sheet pulled through the driver without holding it."""
