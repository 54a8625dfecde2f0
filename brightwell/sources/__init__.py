"""Table sources, synchronisation jobs and exports."""
