"""Runnable jobs over tables of text: each has a function that takes a session, a command line and a small config file beside it."""
