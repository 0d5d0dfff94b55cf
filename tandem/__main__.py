from tandem.cli import main

main()
