"""DataFrame operators: term statistics, lexicon joins, sentiment, models, tuning."""
