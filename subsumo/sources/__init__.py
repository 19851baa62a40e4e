"""Tables, catalog schemas and delimited files as inputs."""
