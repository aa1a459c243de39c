"""Runnable jobs over the set engine: a function that takes a session, a command line and a config file each."""
