"""DataFrame operators shared by the jobs: as-of lookups, series windows, exact peer positions, name resolution, merges."""
