"""Operations of a training-data pipeline: packing, formatting, filtering, duplicate search, coding."""
