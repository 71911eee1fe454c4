from sondage.cli import main

raise SystemExit(main())
