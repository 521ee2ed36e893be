"""Named results composed from operators."""
