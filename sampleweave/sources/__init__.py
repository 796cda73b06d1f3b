"""Sources and sinks: generators, raw and WAV files, a gated HTTP source, NMEA sentences."""
