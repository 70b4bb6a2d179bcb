"""Training-data operators; ``registry`` lists their queries. Nothing outside this subpackage imports it."""
