"""No streaming operators: every input of this workload is a whole-table batch read."""
