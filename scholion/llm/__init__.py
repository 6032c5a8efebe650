"""Operations of a training-data pipeline: cleaning, de-duplication, mixing and tokenising of a text corpus."""
