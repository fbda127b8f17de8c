"""Sources and sinks."""

from quarrylight.sources import office  # noqa: E402, F401  (registers its readers)
