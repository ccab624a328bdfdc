"""locusframe.sinks"""
