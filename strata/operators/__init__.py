"""DataFrame-to-DataFrame operators; none of them touches storage."""
