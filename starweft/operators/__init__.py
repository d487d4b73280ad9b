"""DataFrame operators; each module states its results for nulls, ties, repeats and empty inputs."""
