"""DataFrame operators: joins, windows, graphs, holds, metrics, checks."""
