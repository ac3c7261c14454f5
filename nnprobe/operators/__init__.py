"""DataFrame operators: profile, sampling, kNN, inverted file, recall, measurement statistics, nearest reference."""
