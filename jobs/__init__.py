"""Runnable jobs on top of the library; each module has a command line and a config file of its name."""
