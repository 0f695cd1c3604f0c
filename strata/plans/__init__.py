"""Layer runs, star schema and the analyst queries on top."""
