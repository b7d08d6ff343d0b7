"""Column functions: paths, digests, requests, modes and the binary layout of images."""
