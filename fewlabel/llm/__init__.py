"""Operations of a training-data pipeline over raw text, pages and vectors."""
