"""Question understanding: questions in, plans out, one row per question."""
