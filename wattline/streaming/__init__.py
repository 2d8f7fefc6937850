from wattline.streaming.load_stream import stream_load  # noqa: F401
