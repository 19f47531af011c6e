"""The registered queries, their input views and their SQL oracles."""
