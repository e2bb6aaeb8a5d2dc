"""DataFrame operators. Lazy unless a docstring says that it runs a job."""
