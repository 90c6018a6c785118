"""End-to-end flows, responders, the registered queries with their DuckDB
oracles, and the derived test inputs."""
