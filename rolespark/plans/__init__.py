"""The workloads, put together from operators."""
