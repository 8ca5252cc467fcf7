"""graphmill: preparing, checking and scoring corpora of sentence-level semantic graphs on Spark."""
