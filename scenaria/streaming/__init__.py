from scenaria.streaming.rollup import finish, running_state, start

__all__ = ["running_state", "finish", "start"]
